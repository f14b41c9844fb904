import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int, words: list[str]) -> str:
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text, lang, source) rows, with further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    def build(rows):
        df = spark.createDataFrame([(*r[:2], *(r[2:4] if len(r) > 2 else ("en", "s0")), len(r[1]) if r[1] is not None else None) for r in rows], COLUMNS)
        clash = ["fp", "keep_id", "digest", "n", "rank", "g", "bucket", "slot", "_id", "row_id", "x1", "label", "id", "key"]
        return df.withColumns({c: F.lit("z") for c in clash})

    return build


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, long and empty texts, ties, nulls and repeated rows."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows = [(i, prose(r, r.randint(1, 160), words), r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", None])) for i in range(60)]
    base = rows[7][1] + " " + prose(r, 120, words)
    for k in range(12):  # near copies of one text
        w = base.split()
        for _ in range(k):
            w[r.randrange(len(w))] = "changed%d" % r.randrange(9)
        rows.append((100 + k, " ".join(w), "en", "s0"))
    rows += [(200 + k, rows[5][1].upper() if k % 2 else rows[5][1], "en", "s1") for k in range(6)]
    passage = prose(r, 90, words)
    rows += [(300 + k, f"{prose(r, 9, words)} {passage} {prose(r, 9, words)}", "fr", "s0") for k in range(5)]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, " \n\t ", "en", "s0"), (403, "x", "en", "s0"), (404, "é É ß\nß ß", "fr", "s1")]
    rows += [(500, prose(r, 20_000, words), "en", "s0"), (501, "ab " * 700, "en", "s0")]
    rows += [(None, "no id here at all", "en", "s0"), (600, "twice the same row", "en", "s0"), (600, "twice the same row", "en", "s0")]
    return rows
