"""Fill-in-the-middle rewriting with cuts at units found in an indexable skip list.

A text is a sequence of units, lines here.  The bottom lane of the list holds one node per
unit, each lane above one node per ``FAN`` nodes below; every node carries its width twice,
in units and in code points.  A cut after ``rank`` units is found by walking the top lane
while the widths added up stay within ``rank``, then descending: the units add up to the
rank exactly, and the code points to the place of the cut.  Both cuts of a text share the
list.  A walk takes ``FAN`` steps a lane at most.

Ranks, and the choice of form, come from a seeded SHA-256 of the id, so that retries and
other engines agree.  Texts that hold one of the markers stay as they are, since their
parts could not be told apart afterwards; from all others ``restore`` rebuilds the text.

Defined results: null text is empty; an empty text is plain and has no units; a null id
hashes as the empty text, so such rows are cut alike; repeated rows each get their row;
result columns replace input columns of the same name, others pass through; no rows give
no rows.  A unit of megabytes is one node like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.llm.common import carries, text_or_empty, with_result

SEED = 7
#: Percent of the texts that are rewritten, and percent of those whose suffix comes first.
RATE = 100
SUFFIX_FIRST = 50
#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Nodes of a lane below one of the next.
FAN = 8


class SkipList:
    """Units by rank; ``lanes[0]`` has one node per unit, as ``(units, code points)`` of each node."""

    def __init__(self, widths: Sequence[int], fan: int = FAN):
        self.fan = fan
        self.lanes = [([1] * len(widths), list(widths))]
        while len(self.lanes[-1][0]) > fan:
            units, points = self.lanes[-1]
            starts = range(0, len(units), fan)
            self.lanes.append(([sum(units[i : i + fan]) for i in starts], [sum(points[i : i + fan]) for i in starts]))

    def __len__(self) -> int:
        return sum(self.lanes[-1][0])

    def offset(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        passed = place = node = 0
        for units, points in reversed(self.lanes):
            node *= self.fan
            while node < len(units) and passed + units[node] <= rank:
                passed += units[node]
                place += points[node]
                node += 1
        if passed != rank:
            raise IndexError(rank)
        return place


def line_widths(text: str) -> list[int]:
    """Code points of each line, its line feed included; no line starts behind the last feed."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def _drawn(row_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cuts(text: Column, one: Column, other: Column) -> Column:
    """``n`` units of ``text`` and the places of its two cuts, from two drawn numbers."""

    @F.pandas_udf("struct<n: long, first: long, second: long>")
    def cut(texts: pd.Series, ones: pd.Series, others: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x, y in zip(texts, ones, others):
            units = SkipList(line_widths(t))
            n = len(units)
            rows.append((n, *(units.offset(r) for r in sorted((x % (n + 1), y % (n + 1))))))
        return pd.DataFrame(rows, columns=["n", "first", "second"], dtype="int64")

    return cut(text, one, other)


@carries("id_column", "text_column")
def transform(
    docs: DataFrame,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the rewritten ``output``."""
    text = text_or_empty(text_column)
    h1, h2, h3, h4 = _drawn(F.col(id_column), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    staged = docs.select(F.struct("*").alias("row"), text.alias("text"), form.alias("form"), _cuts(text, h1, h2).alias("cut"))

    t, first, second = F.col("text"), F.col("cut.first"), F.col("cut.second")
    prefix, middle = F.substring(t, F.lit(1), first), F.substring(t, first + 1, second - first)
    suffix = F.substring(t, second + 1, F.char_length(t) - second)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(t)
    )
    cut = F.col("form") != "plain"
    result = {
        "n": F.col("cut.n"),
        "form": F.col("form"),
        "prefix_chars": F.when(cut, first),
        "middle_chars": F.when(cut, second - first),
        "output": output,
    }
    clash = set(result)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in clash]
    return staged.select(*kept, *[v.alias(k) for k, v in result.items()])


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    A rewritten text has each marker once: its parts have none, and no end of a marker is
    the start of another, so none can arise where parts meet.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_forms(docs: DataFrame) -> DataFrame:
    """The registered form: digests of the output and of the text rebuilt from it."""
    done = transform(docs.select("doc_id", "text"))
    return with_result(
        done.drop("text"),
        output_sha256=F.sha2("output", 256),
        restored_sha256=F.sha2(restore(F.col("output"), F.col("form")), 256),
    ).drop("output")


SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), units AS (
    SELECT doc_id, t,
        ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4,
        CASE WHEN t = '' THEN 0 WHEN right(t, 1) = chr(10) THEN len(string_split(t, chr(10))) - 1
             ELSE len(string_split(t, chr(10))) END AS n,
        string_split(t, chr(10)) AS lines
    FROM drawn
), ranks AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS r1, greatest(h1 % (n + 1), h2 % (n + 1)) AS r2,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM units
), places AS (
    SELECT *,
        least(length(t), CASE WHEN r1 = 0 THEN 0 ELSE length(array_to_string(lines[1:r1], chr(10))) + 1 END) AS c1,
        least(length(t), CASE WHEN r2 = 0 THEN 0 ELSE length(array_to_string(lines[1:r2], chr(10))) + 1 END) AS c2
    FROM ranks
), parts AS (
    SELECT *, substring(t, 1, c1) AS p, substring(t, c1 + 1, c2 - c1) AS m, substring(t, c2 + 1) AS s FROM places
)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN c1 END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN c2 - c1 END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
           ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
