import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


#: More names of columns that a table may have already.
UNDERSCORED = "_id _hash _th _d _isles _words _bits _kept _size _copy _repeats n_lines n_removed words_removed hash kept_id of whole last times predicted segment bits isles words".split()


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(data, schema)
        # names that operators use inside
        return df.selectExpr("*", "1 as id", "2 as n", "'x' as th", "3 as size", "4 as key", "5 as d", "6 as i", "7 as score", *(f"'{n}' as {n}" for n in UNDERSCORED)) if extra else df

    return make
