"""Fill-in-the-middle transformation of whole texts.

A text is cut into units (a word with the white space before it, or trailing white space). Two cuts
drawn from a hash of the seed and doc_id make prefix, middle and suffix; the form is plain, psm
(prefix, suffix, middle) or spm (suffix, prefix, middle), each part behind its marker. A pandas
UDF takes Arrow batches, whose bytes Spark bounds (spark.sql.execution.arrow.maxBytesPerBatch); of
a text it keeps one array of unit ends, and two lookups in it give the cuts. There is no shuffle.

Defined results: a null text counts as empty; an empty text, or one that holds a marker, is plain
and stays as it is, and has no prefix or middle; a null doc_id draws from the seed alone; rows that
repeat a doc_id draw alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.llm.common import ids_and_text

# fixed values
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    """The end of each unit in code points; the units follow each other without gaps."""
    return array("q", (m.end() for m in UNIT.finditer(text)))


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the hash of seed and doc_id."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str, doc_id: int | None, seed: str, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's and middle's code points, output)."""
    ends = unit_ends(text)
    n = len(ends)
    one, two, whether, which = draws(seed, doc_id)
    if not n or whether % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, PLAIN, None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if which % 100 < spm_rate:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of this form was made from. No part holds a marker, so each is found at its first place."""
    if form == PLAIN:
        return output
    one, two = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    first, _, rest = output.removeprefix(one).partition(two)
    second, _, middle = rest.partition(MIDDLE)
    return first + middle + second if form == PSM else second + middle + first


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fim(doc_id: Column, text: Column, seed: str, rate: int, spm_rate: int) -> Column:
    @F.pandas_udf(RESULT)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        # ids come as decimal strings: a null among longs would turn them into floats
        rows = [transformed(t or "", i, seed, rate, spm_rate) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        for c in ("prefix_chars", "middle_chars"):
            out[c] = out[c].astype("Int64")
        out["output_sha256"] = [sha256(x) for x in out["output"]]
        return out

    return cut(doc_id.cast("string"), text)


@F.pandas_udf(StringType())
def restored_text(output: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([restored(o, f) for o, f in zip(output, form)], dtype=object)


@F.pandas_udf(StringType())
def restored_sha256(output: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([sha256(restored(o, f)) for o, f in zip(output, form)], dtype=object)


def fill_in_middle(docs: DataFrame, seed: int | str = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars, output (the transformed text) and output_sha256.

    rate: of a hundred texts, how many are transformed; spm_rate: of a hundred of those, how many as spm.
    """
    src = ids_and_text(docs, id_col, text_col)
    return src.select("doc_id", fim(F.col("doc_id"), F.col("text"), str(seed), rate, spm_rate).alias("fim")).select("doc_id", "fim.*")


def with_restored_digest(made: DataFrame) -> DataFrame:
    """fill_in_middle's rows with the digest of the text rebuilt from output and form alone; the output goes."""
    return made.withColumn("restored_sha256", restored_sha256("output", "form")).drop("output")


def oracle_sql(seed: int | str = 42, rate: int = 50, spm_rate: int = 80) -> str:
    """The query's rows from lists of units."""
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM t),
        d AS (SELECT *, len(units) AS n, {draw(0)} % (len(units) + 1) AS x, {draw(1)} % (len(units) + 1) AS y,
                CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {draw(2)} % 100 >= {rate} THEN '{PLAIN}'
                    WHEN {draw(3)} % 100 < {spm_rate} THEN '{SPM}' ELSE '{PSM}' END AS form FROM u),
        p AS (SELECT *, coalesce(array_to_string(units[1:least(x, y)], ''), '') AS a, coalesce(array_to_string(units[least(x, y) + 1:greatest(x, y)], ''), '') AS b,
                coalesce(array_to_string(units[greatest(x, y) + 1:n], ''), '') AS c FROM d)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
            CASE WHEN form <> '{PLAIN}' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> '{PLAIN}' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN '{PLAIN}' THEN text WHEN '{PSM}' THEN '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b ELSE '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p"""
